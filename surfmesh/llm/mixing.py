"""Mixing sources to target weights by Pfair scheduling; rows are handled with DataFrame and SQL functions alone.

Each source's rows are numbered and cut in blocks. With weights as integers q(s) that add up to H, block j (from 0) of source s is released
at floor(j H / q) and due by ceil((j + 1) H / q). In every slot the earliest deadline among the released blocks wins. The weights are taken
exactly, as the fractions that their doubles are, so that at any slot, while no source has run dry, each source is less than one block
away from its target share, however many blocks there are. The driver works out the slots, in one step a block; blocks grow with the table, so
that there are about MOST_BLOCKS of them at most.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.llm.common import at, cut, md5_bits, packed, unpacked

#: Rows of a source that are numbered as one run.
RUN_ROWS = 2_000
#: Runs whose rows are added up as one, and slots in a row of the schedule's table.
RUN_GROUP, SLOTS = 4096, 16_384
#: Blocks that all sources together have at most, but for one more each.
MOST_BLOCKS = 1 << 22
#: Rows of the tables of sources, of runs and of slots that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: What mixed() adds, in place of columns of these names.
ADDED = ("_block", "_slot", "_position", "_in_target")


def schedule_sql(quanta: str = "q") -> str:
    """SQL for the sources (positions in the array of quanta) of the slots of one period, earliest deadline first.

    Ties go to the lower position. On one server with unit jobs this meets every deadline, as the quanta add up to the period. The slots of
    mixed() are those of scheduled(), which this states in SQL for small whole quanta.
    """
    pick = f"""array_min(filter(transform({quanta}, (w, s) -> if(a.done[s] * a.h div w <= t, struct(((a.done[s] + 1) * a.h + w - 1) div w as due, s as s), null)), x -> x is not null)).s"""
    step = f"transform(array({pick}), p -> named_struct('h', a.h, 'done', transform(a.done, (d, s) -> if(s = p, d + 1L, d)), 'out', concat(a.out, array(p))))[0]"
    start = f"named_struct('h', aggregate({quanta}, 0L, (x, w) -> x + w), 'done', transform({quanta}, w -> 0L), 'out', cast(array() as array<int>))"
    return f"aggregate(sequence(0L, aggregate({quanta}, 0L, (x, w) -> x + w) - 1L), {start}, (a, t) -> {step}, a -> a.out)"


def exact(weights: list[float]) -> list[int]:
    """Integers in just the proportions of these doubles."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    whole = max((d for _, d in ratios), default=1)  # all are powers of two
    return [n * (whole // d) for n, d in ratios]


def scheduled(quanta: list[int], blocks: list[int]) -> tuple[list[list[int]], int]:
    """The slots of each source's blocks, and the first slot that finds its source dry, earliest deadline first.

    Ties go to the lower position, as in schedule_sql(). Later than that slot, blocks that aren't there leave their slots to others, so that no
    slot is empty.
    """
    h, slots = sum(quanta), [[] for _ in quanta]
    ready = [(-(-h // q), s, 0) for s, q in enumerate(quanta)]
    heapify(ready)
    waiting: list[tuple[int, int, int]] = []
    now, slot, end, total = 0, 0, None, sum(blocks)
    while slot < total:
        while waiting and waiting[0][0] <= now:
            _, s, j = heappop(waiting)
            heappush(ready, (-(-(j + 1) * h // quanta[s]), s, j))
        if not ready:
            now = waiting[0][0]
            continue
        _, s, j = heappop(ready)
        if j == blocks[s]:
            end = slot if end is None else end
            continue
        slots[s].append(slot)
        slot, now = slot + 1, now + 1
        heappush(waiting, ((j + 1) * h // quanta[s], s, j + 1))
    return slots, slot if end is None else end


def groups_of(counts: DataFrame, source_col: str, weights: dict[str | None, float] | None, power: float, period: int | None, sources: int | None) -> DataFrame:
    """(source, g, n, w, q) of every source that has a weight of its own, and of the pool (source null, pool true): g numbers them. q is the
    weight in whole quanta of the period, if there is one."""
    if weights is not None:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("weights: all above 0")
        spark = counts.sparkSession
        listed = spark.createDataFrame([(k, float(w)) for k, w in weights.items() if k is not None] or [("", 0.0)], "_s string, _w double")
        ranked = counts.join(F.broadcast(listed), F.col(source_col).cast("string") == F.col("_s"), "left").withColumn("_own", F.col("_w").isNotNull())
    else:
        rank = F.row_number().over(Window.orderBy(F.desc("n"), F.col(source_col).asc_nulls_last()))
        ranked = counts.withColumn("_own", rank <= sources if sources else F.lit(True)).withColumn("_w", F.pow("n", F.lit(power)))
    key = F.struct((~F.col("_own")).alias("pool"), F.when(F.col("_own"), F.col(source_col)).alias("source"))
    pooled = ranked.groupBy(key.alias("k")).agg(F.sum("n").alias("n"), F.sum("_w").alias("w"))
    default = float(weights.get(None, min(weights.values()))) if weights else None
    weight = F.coalesce("w", F.lit(default).cast("double"))
    sized = pooled.select("k.pool", F.col("k.source").alias("_source"), "n", weight.alias("w"))
    whole = Window.partitionBy(F.lit(0))
    q = F.greatest(F.lit(1), F.round(F.col("w") / F.sum("w").over(whole) * period)) if period else F.lit(None)
    sized = sized.withColumn("q", q.cast("bigint"))
    return sized.withColumn("g", (F.row_number().over(Window.orderBy("pool", F.col("_source").asc_nulls_first())) - 1).cast("int"))


def placed(docs: DataFrame, *, weights: dict[str | None, float] | None = None, power: float = 0.5, block: int = 64, period: int | None = None, sources: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, int]:
    """The rows of docs (as _doc) with the columns of ADDED, and how many positions there are; options and rules as for mixed()."""
    counts = docs.groupBy(at(source_col).alias("_source")).agg(F.count("*").alias("n"))
    groups = groups_of(counts, "_source", weights, power, period, sources)
    # A row for each source: the pool is read as a value.
    rows = cut(groups.select("pool", "_source", "n", "w", "q", "g").withColumn("_runs", F.ceil(F.col("n") / RUN_ROWS)))
    n_own, pool_g, pool_runs, n_runs = rows.agg(F.count("*"), F.max(F.when(F.col("pool"), F.col("g"))), F.max(F.when(F.col("pool"), F.col("_runs"))), F.coalesce(F.sum("_runs"), F.lit(0))).first()
    h, tie = md5_bits(at(id_col), at(text_col)), F.xxhash64(at(text_col).cast("string"))
    own = rows.where("not pool").select(F.col("_source").alias("_s"), F.col("g").alias("_g1"), F.col("_runs").alias("_r1"))
    named = packed(docs, _h=h, _tie=tie, _id=at(id_col), _source=at(source_col)).join(F.broadcast(own) if n_own <= BROADCAST_ROWS else own, F.col("_source").eqNullSafe(F.col("_s")), "left")
    named = named.select("_doc", "_id", "_h", "_tie", F.coalesce(F.col("_g1"), F.lit(pool_g).cast("int")).alias("_g"), F.pmod("_h", F.coalesce(F.col("_r1"), F.lit(pool_runs).cast("bigint"))).alias("_run"))
    runs = named.groupBy("_g", "_run").agg(F.count("*").alias("_rows"))
    # Rows ahead of a run: those of the groups of runs before its own, and of the runs before it in its group.
    runs = runs.withColumn("_part", F.floor(F.col("_run") / RUN_GROUP))
    before = lambda by, order: F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = runs.groupBy("_g", "_part").agg(F.sum("_rows").alias("_rows")).select("_g", "_part", before(["_g"], "_part").alias("_far"))
    ahead = runs.select("_g", "_part", "_run", before(["_g", "_part"], "_run").alias("_near")).join(parts, ["_g", "_part"]).select("_g", "_run", (F.col("_far") + F.col("_near")).alias("_ahead"))
    in_run = named.withColumn("_i", F.row_number().over(Window.partitionBy("_g", "_run").orderBy("_h", "_id", "_tie")) - 1)
    i = F.col("_i") + F.col("_ahead")
    listed = rows.orderBy("g").select("n", "w", "q").collect()
    block = max(block, -(-sum(r.n for r in listed) // MOST_BLOCKS))
    # One projection: through two, Spark doesn't prune the columns of _doc.
    numbered = in_run.join(F.broadcast(ahead) if n_runs <= BROADCAST_ROWS else ahead, ["_g", "_run"]).withColumns({"_i": i, "_block": F.floor(i / block).cast("long")})
    blocks = [-(-r.n // block) for r in listed]
    slots, end = scheduled([r.q for r in listed] if period else exact([r.w for r in listed]), blocks)
    table = [(g, lo, own[lo : lo + SLOTS]) for g, own in enumerate(slots) for lo in range(0, len(own), SLOTS)]
    table = docs.sparkSession.createDataFrame(table, "_sg int, _lo long, _slots array<long>")
    places = cut(table.select("_sg", "_lo", F.posexplode("_slots").alias("_at", "_slot")).select("_sg", (F.col("_lo") + F.col("_at")).alias("_nth"), "_slot"))
    found = numbered.join(F.broadcast(places) if sum(blocks) <= BROADCAST_ROWS else places, (F.col("_g") == F.col("_sg")) & (F.col("_block") == F.col("_nth")))
    position = F.col("_slot") * block + F.pmod(F.col("_i"), F.lit(block))
    return found.select("_doc", "_block", "_slot", position.cast("long").alias("_position"), (F.col("_slot") < end).alias("_in_target")), sum(blocks) * block


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs once, with _block (of its source), _slot (of the schedule), _position (rows of the mix come in this order) and
    _in_target (before any source ran dry, so the target holds), in place of columns of these names.

    weights: of the named sources; the others are pooled with the weight of the key None (the least weight if that is missing). Without
    weights each source's is its number of rows to the given power. With a period, weights are rounded to whole quanta of it (1 at least), and
    the target is that of the rounded ones. Every source is scheduled by itself, unless `sources` asks for the largest alone: the others are
    then pooled, with the sum of their weights. A block has `block` rows, or so many that there are MOST_BLOCKS; the driver holds a number for
    each block and each source. Rows of one source are ordered by a hash of their id (of their text where the id is null), then by id, then by
    a hash of the text; rows equal in both change places freely. A null source is a source like others; repeated rows are rows like any
    other; null and empty texts are rows with a null or empty text; an empty table gives an empty table. Options: see placed().
    """
    return placed(docs, **options)[0].select(*unpacked(docs.columns, ADDED), *ADDED)


def laid_out(docs: DataFrame, rows: int = 20_000, **options) -> DataFrame:
    """The rows of docs in the order of the mix, all columns as they were, whatever they are called: partitions, and so the files that they are
    written to, hold about `rows` positions each (fewer on tables too small to give every core some) and follow each other.

    Rows are mixed as by mixed(), which also says what nulls, ties, repeated rows and empty tables give.
    """
    found, positions = placed(docs, **options)
    parts = max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism, -(-positions // rows))
    part: Column = F.floor(F.col("_position") * parts / max(1, positions)).cast("int")
    return found.select("_doc", "_position").repartitionById(parts, part).sortWithinPartitions("_position").select(*unpacked(docs.columns))
