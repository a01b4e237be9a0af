"""Dependencies between transactions: conflicts, edges, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import granularity_rank, lock_granularity, xid32
from .log import tracked_writes

#: Readers that a span of a writer meets at once, about; copies of what meets writers of one table or class, so that no task has them all.
BLOCK, SALTS = 512, 8


def ww_conflicts(history: DataFrame, txid: int | None = None) -> DataFrame:
    """(txid, depends_on): later writers of a key that depends_on wrote. One target or all."""
    h = tracked_writes(history).select("table_name", "pk_text", "txid", "id").repartition("table_name", "pk_text")  # met, grouped and joined where it lies
    target = h if txid is None else h.filter(F.col("txid") == txid)
    last = target.groupBy("table_name", "pk_text", F.col("txid").alias("depends_on")).agg(F.max("id").alias("last_id"))
    return h.join(last, ["table_name", "pk_text"]).filter((F.col("id") > F.col("last_id")) & (F.col("txid") != F.col("depends_on"))).select("txid", "depends_on").distinct()


def readers(history: DataFrame) -> DataFrame:
    """32-bit reader id -> its least transaction with a tracked write, and that one's last commit."""
    by_txid = tracked_writes(history).groupBy("txid").agg(F.max("committed_at").alias("read_at")).withColumn("reader_xid", xid32(F.col("txid")))
    first = F.min_by(F.struct("txid", "read_at"), "txid").alias("r")
    return by_txid.groupBy("reader_xid").agg(first).select("reader_xid", F.col("r.txid").alias("txid"), F.col("r.read_at").alias("read_at"))


def _resolved(history: DataFrame, read_set: DataFrame, match_blocks: bool, since=None) -> DataFrame:
    """Reads with their transaction and its last commit; since: only of those that committed at or after it."""
    known = readers(history)
    known = known if since is None else known.filter(F.col("read_at") >= since)
    columns = ["table_name", "read_pk", "locktype", "txid", "read_at"] + ["blk"] * match_blocks
    return read_set.join(known, "reader_xid").select(*columns).distinct()


def _precise() -> Column:
    return (F.col("locktype") == 2) & F.col("read_pk").isNotNull()


def _exact_edges(reads: DataFrame, h: DataFrame) -> DataFrame:
    """Distinct (txid, depends_on, table_name) of reads that met writes on a key."""
    writes = h.repartition("table_name", "pk_text").groupBy("table_name", "pk_text", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("written_at"))
    guard = (F.col("read_at") >= F.col("written_at")) & (F.col("txid") != F.col("depends_on"))
    return reads.filter(_precise()).withColumnRenamed("read_pk", "pk_text").join(writes, ["table_name", "pk_text"]).filter(guard).select("txid", "depends_on", "table_name").distinct()


def _wide_reads(reads: DataFrame, match_blocks: bool, whole_reader: bool) -> DataFrame:
    """(cls, members, txid, read_at): reads that meet more than a key, by what they read.

    A member is (rank, table_name, granularity, blks), without blks if the whole table is read. A
    class is one member or, if whole_reader, all of a reader's members, most precise first; cls
    is its digest.
    """
    wide = reads.filter(~_precise() | F.col("read_pk").isNull()).withColumn("granularity", lock_granularity(F.col("locktype")))
    page = F.when(F.col("locktype") == 1, F.col("blk")) if match_blocks else F.lit(None).cast("long")
    grouped = wide.withColumn("page", page).groupBy("txid", "read_at", "table_name", "granularity").agg(F.bool_or(F.col("page").isNull()).alias("whole"), F.array_sort(F.collect_set("page")).alias("pages"))
    member = F.struct(granularity_rank(F.col("granularity")).alias("rank"), "table_name", "granularity", F.when(~F.col("whole"), F.col("pages")).alias("blks"))
    if whole_reader:
        out = grouped.groupBy("txid", "read_at").agg(F.array_sort(F.collect_list(member)).alias("members"))
    else:
        out = grouped.select("txid", "read_at", F.array(member).alias("members"))
    return out.select(F.unhex(F.sha2(F.to_json("members"), 256)).alias("cls"), "members", "txid", "read_at")


def _salted(df: DataFrame) -> DataFrame:
    """A copy of each row for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.hash("depends_on"), F.lit(SALTS))


def _members(wide: DataFrame) -> DataFrame:
    """(cls, pos, last_at and a member's columns): a row for each member of a class, whose last read was at last_at."""
    classes = wide.groupBy("cls").agg(F.first("members").alias("members"), F.max("read_at").alias("last_at"))
    return classes.select("cls", "last_at", F.posexplode("members").alias("pos", "m")).select("cls", "last_at", "pos", "m.*")


def _in_time(h: DataFrame, members: DataFrame) -> DataFrame:
    """Writes that were committed by the last wide read of their table: no other one is met. A row for each table is broadcast."""
    last = members.groupBy("table_name").agg(F.max("last_at").alias("table_last"))
    return h.join(F.broadcast(last), "table_name").filter(F.col("committed_at") <= F.col("table_last")).drop("table_last")


def _spans(wide: DataFrame, h: DataFrame, match_blocks: bool) -> DataFrame:
    """(cls, depends_on, rank, table_name, granularity, since, until): when a writer is met by readers of a class, and by which member.

    A read at or after since, and before until if there is one, meets it by that member and by no
    more precise one, so spans of a writer don't overlap: no pair is found twice.
    """
    members = _members(wide)
    h = _in_time(h, members)
    by_table = h.groupBy("table_name", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("at")).withColumn("salt", _salt())
    on = ["cls", "pos", "rank", "table_name", "granularity", "depends_on"]
    met = by_table.join(_salted(members.filter("blks IS NULL")), ["table_name", "salt"]).filter("at <= last_at").select(*on, "at")
    if match_blocks:
        placed = h.groupBy("table_name", "blk", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("at")).withColumn("salt", _salt())
        paged = members.filter("blks IS NOT NULL")
        in_block = placed.join(_salted(paged.withColumn("blk", F.explode("blks"))), ["table_name", "blk", "salt"]).filter("at <= last_at").select(*on, "at")
        anywhere = placed.filter("blk IS NULL").drop("blk").join(_salted(paged), ["table_name", "salt"]).filter("at <= last_at").select(*on, "at")
        met = met.unionByName(in_block.unionByName(anywhere).groupBy(*on).agg(F.min("at").alias("at")))
    before = Window.partitionBy("cls", "depends_on").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = met.withColumn("until", F.min("at").over(before)).filter("until IS NULL OR at < until")
    return spans.select("cls", "depends_on", "rank", "table_name", "granularity", F.col("at").alias("since"), "until")


def _spans_of_members(wide: DataFrame, h: DataFrame, match_blocks: bool) -> tuple[DataFrame, DataFrame]:
    """(wide, spans) of classes of one member each, with less to list than _spans.

    As nothing is more precise than the only member, no window is needed. Writes without a block
    meet every page read of their table, so they are not listed for each set of pages: the page
    readers of a table get one more class, that meets these writes; a span by block ends where
    they begin.
    """
    members = _members(wide)
    h = _in_time(h, members)
    given = ["cls", "depends_on", "rank", "table_name", "granularity"]
    by_table = h.groupBy("table_name", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("since")).withColumn("salt", _salt())
    never = F.lit(None).cast(h.schema["committed_at"].dataType).alias("until")
    met = by_table.join(_salted(members.filter("blks IS NULL")), ["table_name", "salt"]).filter("since <= last_at").select(*given, "since", never)
    if not match_blocks:
        return wide, met
    placed = h.groupBy("table_name", "blk", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("at")).withColumn("salt", _salt())
    paged = _salted(members.filter("blks IS NOT NULL").withColumn("blk", F.explode("blks")))
    in_block = placed.join(paged, ["table_name", "blk", "salt"]).filter("at <= last_at").groupBy(*given).agg(F.min("at").alias("since"))
    anywhere = placed.filter("blk IS NULL").select("table_name", "depends_on", F.col("at").alias("until"))
    placed_first = in_block.join(anywhere, ["table_name", "depends_on"], "left").filter("until IS NULL OR since < until").select(*given, "since", "until")
    member = F.col("members")[0]
    joint = F.unhex(F.sha2(F.to_json(F.struct(member["rank"], member["table_name"], F.lit("page readers"))), 256))
    readers_of_pages = wide.filter(member["blks"].isNotNull()).withColumn("cls", joint)
    kinds = readers_of_pages.groupBy("cls").agg(F.first(member).alias("m"), F.max("read_at").alias("last_at")).select("cls", "last_at", "m.*").drop("blks")
    unplaced = anywhere.withColumn("salt", _salt()).join(_salted(kinds), ["table_name", "salt"]).filter("until <= last_at").select(*given, F.col("until").alias("since"), never)
    return wide.unionByName(readers_of_pages), met.unionByName(placed_first).unionByName(unplaced)


def _within() -> Column:
    return (F.col("read_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("read_at") < F.col("until")))


def _met_by(pairs: DataFrame, wide: DataFrame, spans: DataFrame) -> DataFrame:
    """Of the pairs (txid, depends_on), those that wide reads meet, with the columns of the span."""
    return pairs.join(wide.select("txid", "cls", "read_at"), "txid").join(spans, ["cls", "depends_on"]).filter(_within())


def _list_pairs(wide: DataFrame, spans: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(txid, depends_on, table_name, granularity, rank): every reader of a class with every writer whose span it is in, but not the pairs of skip.

    Each pair is made once, so none is shuffled: readers of a class are put together in blocks of
    neighbours in time, at most some BLOCK of them; a span goes to the blocks it overlaps, and is
    unfolded there. What moves is a row for each span and block. These rows are few beside the
    pairs, so how many tasks unfold them is fixed, not left to their size.
    """
    tasks = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * wide.sparkSession.sparkContext.defaultParallelism)
    hour = F.date_trunc("hour", "read_at")
    per_hour = wide.groupBy("cls", hour.alias("hour")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deal = per_hour.select("cls", "hour", F.floor(before / BLOCK).alias("part"), F.ceil(F.col("n") / BLOCK).alias("ways"))
    dealt = wide.select("cls", hour.alias("hour"), "txid", "read_at").join(deal, ["cls", "hour"]).withColumn("sub", F.pmod(F.hash("txid"), F.col("ways").cast("int"))).select("cls", "part", "sub", "txid", "read_at")
    key = ["cls", "part", "sub"]
    blocks = dealt.groupBy(*key).agg(F.collect_list(F.struct("txid", "read_at")).alias("block"), F.min("read_at").alias("lo"), F.max("read_at").alias("hi"))
    near = (F.col("hi") >= F.col("since")) & (F.col("until").isNull() | (F.col("lo") < F.col("until")))
    tiles = spans.withColumn("salt", _salt()).join(_salted(blocks.select(*key, "lo", "hi")), ["cls", "salt"]).filter(near).drop("lo", "hi")
    keep = (F.col("txid") != F.col("depends_on")) & _within()
    if skip is not None:
        without = skip.join(dealt.drop("read_at"), "txid").groupBy(*key, "depends_on").agg(F.collect_list("txid").alias("without"))
        tiles = tiles.join(without, [*key, "depends_on"], "left")
        keep = keep & (F.col("without").isNull() | ~F.array_contains("without", F.col("txid")))
    met = tiles.repartition(tasks, *key, "salt").join(_salted(blocks.select(*key, "block")), [*key, "salt"])
    return met.select(*[c for c in tiles.columns if c not in (*key, "salt")], F.inline("block")).filter(keep).select("txid", "depends_on", "table_name", "granularity", "rank")


def rw_edges(history: DataFrame, read_set: DataFrame, *, exact: bool = True, coarse: bool = True, target: int | None = None, match_blocks: bool = False) -> DataFrame:
    """(txid, depends_on, table_name, granularity): reader, writer and how precisely they met.

    A tuple read with a key meets the writes of that key; any other read meets all writes of
    the table. As a join condition with OR would be a nested loop, the classes are a union of
    equi-joins. A reader counts only if it wrote, and not before the write was committed.
    match_blocks: a page read meets the writes of its block (column blk of both sides), and
    those without a block; else, like any coarse read, all writes of its table. target: only
    edges to that writer.
    """
    reads = _resolved(history, read_set, match_blocks)
    h = tracked_writes(history)
    h = h if target is None else h.filter(F.col("txid") == target)
    keyed = _exact_edges(reads, h) if exact else None
    if coarse:
        wide = _wide_reads(reads, match_blocks, False)
        listed = _list_pairs(*_spans_of_members(wide, h, match_blocks)).drop("rank")
        if not exact:
            return listed
        # A reader of the whole table with this label meets the writer there too.
        whole = wide.filter(F.col("members")[0]["rank"] == 1).select("txid", F.col("members")[0]["table_name"].alias("table_name"))
        keyed = keyed.join(whole, ["txid", "table_name"], "left_anti")
    tuples = keyed.select("txid", "depends_on", "table_name", F.lit("tuple").alias("granularity"))
    return tuples.unionByName(listed) if coarse else tuples


def _pairs_of(wide: DataFrame, reads: DataFrame, h: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Distinct pairs that met on a key or are in also, of readers with wide reads: pairs of others can't be met by those."""
    who = wide.select("txid").distinct()
    pairs = _exact_edges(reads.join(who, "txid", "left_semi"), h).select("txid", "depends_on")
    return (pairs if also is None else pairs.unionByName(also.join(who, "txid", "left_semi"))).distinct()


def _best_parts(history: DataFrame, read_set: DataFrame, *, also: DataFrame | None = None, target: int | None = None, match_blocks: bool = False, since=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(near, far, wide, spans): the best edges of pairs that met on a key or are in also; those of all others; what the others come from."""
    reads = _resolved(history, read_set, match_blocks, since)
    h = tracked_writes(history)
    h = h if target is None else h.filter(F.col("txid") == target)
    keyed = _exact_edges(reads, h)
    wide = _wide_reads(reads, match_blocks, True)
    spans = _spans(wide, h, match_blocks)
    pairs = _pairs_of(wide, reads, h, also)
    columns = ["txid", "depends_on", "table_name", "granularity"]
    near = best_edges(keyed.withColumn("granularity", F.lit("tuple")).unionByName(_met_by(pairs, wide, spans).select(columns)))
    return near, _list_pairs(wide, spans, pairs), wide, spans


def best_rw_edges(history: DataFrame, read_set: DataFrame, *, target: int | None = None, match_blocks: bool = False, since=None) -> DataFrame:
    """best_edges(rw_edges(...)), with no shuffle of coarse pairs. since: only edges whose reader last committed at or after it."""
    near, far, *_ = _best_parts(history, read_set, target=target, match_blocks=match_blocks, since=since)
    return near.unionByName(far)


def best_edges(edges: DataFrame) -> DataFrame:
    """One row per (txid, depends_on): the most precise granularity, then the least table."""
    best = F.min(F.struct(granularity_rank(F.col("granularity")).alias("rank"), F.col("table_name"), F.col("granularity"))).alias("b")
    return edges.groupBy("txid", "depends_on").agg(best).select("txid", "depends_on", F.col("b.table_name").alias("table_name"), F.col("b.granularity").alias("granularity"), F.col("b.rank").alias("rank"))


def upgrade_edges(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Upsert of edges: a derived one replaces a stored one only if it is more precise."""
    tagged = stored.select("txid", "depends_on", "granularity", F.lit(0).alias("age")).unionByName(derived.select("txid", "depends_on", "granularity", F.lit(1).alias("age")))
    best = F.min(F.struct(granularity_rank(F.col("granularity")).alias("rank"), F.col("age"), F.col("granularity"))).alias("b")
    return tagged.groupBy("txid", "depends_on").agg(best).select("txid", "depends_on", F.col("b.granularity").alias("granularity"))


def upgraded_edges(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """upgrade_edges of the stored coarse edges by the derived ones of all reads.

    Only a pair that met on a key can have a more precise edge than it had, so the upsert is done
    on those; every other coarse edge stays as it is.
    """
    reads, h = _resolved(history, read_set, False), tracked_writes(history)
    keyed, wide = _exact_edges(reads, h), _wide_reads(reads, False, True)
    spans, pairs = _spans(wide, h, False), _pairs_of(wide, reads, h)
    upserted = upgrade_edges(_met_by(pairs, wide, spans), best_edges(keyed.withColumn("granularity", F.lit("tuple"))))
    return upserted.unionByName(_list_pairs(wide, spans, pairs).select(upserted.columns))


def _ww_rows(ww: DataFrame) -> DataFrame:
    return ww.select("txid", "depends_on", F.lit("ww").alias("kind"), F.lit(None).cast("string").alias("granularity"), F.lit(None).cast("string").alias("table_name"))


def _rw_rows(edges: DataFrame) -> DataFrame:
    return edges.select("txid", "depends_on", F.lit("rw").alias("kind"), "granularity", "table_name")


def conflicts(history: DataFrame, read_set: DataFrame, target: int | None = None, match_blocks: bool = False) -> DataFrame:
    """(txid, depends_on, kind, granularity, table_name) of both kinds, for one target or all."""
    return _ww_rows(ww_conflicts(history, target)).unionByName(_rw_rows(best_rw_edges(history, read_set, target=target, match_blocks=match_blocks)))


def conflict_precision(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """precision(conflicts(...)): a pair met by wide reads alone is one conflict, so only the others are grouped."""
    ww = ww_conflicts(history)
    near, far, *_ = _best_parts(history, read_set, also=ww)
    grouped = precision(_ww_rows(ww).unionByName(_rw_rows(near)))
    alone = far.select("txid", "depends_on", F.lit("rw").alias("kinds"), F.when(F.col("rank") == 1, "exact").otherwise("over-approx").alias("precision"), F.col("granularity").alias("rw_granularity"))
    return grouped.unionByName(alone)


def _reads_in(wide: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with n, the number of their class's reads within them.

    Reads at or after a time are those of later hours, summed once for each hour, and the later
    ones of its own hour; a span has the difference of its two ends.
    """
    ends = spans.withColumn("end", F.explode(F.filter(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("sign"))), lambda e: e["at"].isNotNull())))
    given = ["depends_on", "rank", "table_name", "granularity", "since", "until"]
    points = ends.select("cls", F.col("end.at").alias("at"), F.col("end.sign").alias("sign"), *given, F.lit(0).alias("read"))
    both = points.unionByName(wide.select("cls", F.col("read_at").alias("at"), F.lit(1).alias("read")), allowMissingColumns=True).withColumn("hour", F.date_trunc("hour", "at"))
    here = both.withColumn("here", F.sum("read").over(Window.partitionBy("cls", "hour").orderBy(F.desc("at"))))  # reads at the same time count
    hours = both.groupBy("cls", "hour").agg(F.sum("read").alias("n"))
    later = hours.withColumn("later", F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = here.filter("read = 0").join(later.select("cls", "hour", "later"), ["cls", "hour"])
    return counted.groupBy("cls", *given).agg(F.sum(F.col("sign") * (F.col("here") + F.col("later"))).alias("n"))


def precision_counts(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """precision_summary(conflicts(...)) without listing the coarse conflicts: a span's readers are counted, less those listed and the writer itself."""
    ww = ww_conflicts(history)
    near, _, wide, spans = _best_parts(history, read_set, also=ww)
    listed = near.select("txid", "depends_on").unionByName(ww).distinct()
    own = wide.select("txid", F.col("txid").alias("depends_on"))
    on = ["cls", "depends_on", "rank", "table_name"]
    less = _met_by(listed.unionByName(own), wide, spans).groupBy(*on).agg(F.count("*").alias("less"))
    far = _reads_in(wide, spans).join(less, on, "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).filter("n > 0")
    none = F.lit(None).cast("string")
    coarse = F.when(F.col("rank") > 1, F.col("table_name"))
    parts = (
        listed.select("depends_on", F.lit(1).alias("exact"), F.lit(0).alias("over"), none.alias("t")),
        near.select("depends_on", F.lit(0).alias("exact"), F.lit(0).alias("over"), coarse.alias("t")),
        far.select("depends_on", F.when(F.col("rank") == 1, F.col("n")).otherwise(0).alias("exact"), F.when(F.col("rank") > 1, F.col("n")).otherwise(0).alias("over"), coarse.alias("t")),
    )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total = lambda c: F.sum(c).cast("long").alias(f"{c}_dependents" if c == "exact" else "over_approx_dependents")
    return every.groupBy(F.col("depends_on").alias("txid")).agg(total("exact"), total("over"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("coarse_tables"))


def precision(all_conflicts: DataFrame) -> DataFrame:
    """Per conflict (txid, depends_on): kinds, exact or over-approx, granularity of the read."""
    rank = F.min(F.when(F.col("kind") == "rw", granularity_rank(F.col("granularity"))))
    per = all_conflicts.groupBy("txid", "depends_on").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.bool_or(F.col("kind") == "ww").alias("ww"), rank.alias("rank"))
    label = F.when(F.col("ww") | (F.col("rank") == 1), "exact").otherwise("over-approx")
    return per.select("txid", "depends_on", "kinds", label.alias("precision"), F.when(F.col("rank") == 1, "tuple").when(F.col("rank") == 2, "page").when(F.col("rank") == 3, "relation").alias("rw_granularity"))


def precision_summary(all_conflicts: DataFrame) -> DataFrame:
    """Per target: dependents by label and the tables read coarsely."""
    labels = precision(all_conflicts).groupBy("depends_on").agg(F.count_if(F.col("precision") == "exact").alias("exact_dependents"), F.count_if(F.col("precision") == "over-approx").alias("over_approx_dependents"))
    coarse = all_conflicts.filter("kind = 'rw' AND granularity IN ('page', 'relation')").groupBy("depends_on").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("coarse_tables"))
    return labels.join(coarse, "depends_on", "left").select(F.col("depends_on").alias("txid"), "exact_dependents", "over_approx_dependents", F.coalesce("coarse_tables", F.lit("")).alias("coarse_tables"))


def coarse_report(edges: DataFrame) -> DataFrame:
    """Per table: coarse edges, their readers and writers, and edges by granularity."""
    return edges.filter("granularity IN ('page', 'relation')").groupBy("table_name").agg(
        F.count("*").alias("coarse_edges"), F.countDistinct("txid").alias("readers"), F.countDistinct("depends_on").alias("over_approx_writers"), F.count_if(F.col("granularity") == "page").alias("page_edges"), F.count_if(F.col("granularity") == "relation").alias("relation_edges")
    )


def age_edges(edges: DataFrame, history: DataFrame, cutoff) -> DataFrame:
    """Edges whose reader last committed at or after the cutoff, or has no write at all."""
    old = tracked_writes(history).groupBy("txid").agg(F.max("committed_at").alias("at")).filter(F.col("at") < cutoff)
    return edges.join(old.select("txid"), "txid", "left_anti")


def age_reads(read_set: DataFrame, history: DataFrame, cutoff) -> DataFrame:
    """Reads that stay: those of a 32-bit reader id of which some transaction committed at or after the cutoff, or none wrote."""
    latest = tracked_writes(history).groupBy(xid32(F.col("txid")).alias("reader_xid")).agg(F.max("committed_at").alias("at"))
    return read_set.join(latest.filter(F.col("at") < cutoff).select("reader_xid"), "reader_xid", "left_anti")


def age(edges: DataFrame, read_set: DataFrame, history: DataFrame, now, keep) -> tuple[DataFrame, DataFrame, dict]:
    """(edges, reads, counts) after retention of derived reads; ww edges and history are never touched. keep: a timedelta."""
    if keep is None or keep.total_seconds() < 0:
        raise ValueError("the interval to keep must not be negative or missing")
    cutoff = now - keep
    rw = edges.filter("kind = 'rw'")
    at = F.lit(cutoff).cast(history.schema["committed_at"].dataType)
    left, reads = age_edges(rw, history, at), age_reads(read_set, history, at)
    counts = {"cutoff": cutoff, "deleted_rw_edges": rw.count() - left.count(), "deleted_read_set": read_set.count() - reads.count()}
    return edges.filter("kind <> 'rw'").unionByName(left.select(edges.columns)), reads.select(read_set.columns), counts


def dependent_transactions(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """Transactions that some other one depends on, without listing the edges.

    ww: its last write of a key is not the key's last. rw, exact: a semi-join. rw, coarse:
    some other reader of the table committed late enough; the two latest readers of a table
    decide that, so the work is linear where the edges are quadratic.
    """
    h = tracked_writes(history)
    own = h.groupBy("table_name", "pk_text", "txid").agg(F.max("id").alias("last_id"))
    last = own.withColumn("key_last", F.max("last_id").over(Window.partitionBy("table_name", "pk_text")))
    ww = last.filter("last_id < key_last").select("txid")
    exact = rw_edges(history, read_set, coarse=False).select(F.col("depends_on").alias("txid"))
    coarse_reads = read_set.filter("locktype <> 2 OR read_pk IS NULL").join(readers(history), "reader_xid").select("table_name", "txid", "read_at").distinct()
    latest = F.max(F.struct("read_at", "txid")).alias("top")
    first = coarse_reads.groupBy("table_name").agg(latest)
    second = coarse_reads.join(first, "table_name").filter(F.col("txid") != F.col("top.txid")).groupBy("table_name").agg(F.max("read_at").alias("next_at"))
    tops = first.join(second, "table_name", "left")
    writers = h.groupBy("table_name", "txid").agg(F.min("committed_at").alias("written_at")).join(tops, "table_name")
    coarse = writers.filter(F.when(F.col("top.txid") != F.col("txid"), F.col("top.read_at")).otherwise(F.col("next_at")) >= F.col("written_at")).select("txid")
    return ww.unionByName(exact).unionByName(coarse).distinct()


def classify(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """Every transaction: changes and clean or dependent."""
    marked = dependent_transactions(history, read_set).withColumn("dependent", F.lit(True))
    return tracked_writes(history).groupBy("txid").agg(F.count("*").alias("changes")).join(marked, "txid", "left").select("txid", "changes", F.when(F.col("dependent"), "dependent").otherwise("clean").alias("classification"))


def _readers_from(writers: DataFrame, reads: DataFrame) -> DataFrame:
    """(depends_on, n): distinct other readers of any table a transaction wrote, not before it did, without listing them.

    writers: (table_name, depends_on, written_at); reads: (table_name, txid, read_at), one read_at a reader.
    Readers are counted by the set of tables they read, of which there are few. Against one
    such set a writer has one threshold; the reads past it are those of later hours, summed
    once for each hour, and the later ones of its own hour.
    """
    sets = reads.groupBy("txid", "read_at").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))
    members = sets.select("tables").distinct().withColumn("table_name", F.explode("tables"))
    wanted = writers.join(members, "table_name").groupBy("depends_on", "tables").agg(F.min("written_at").alias("at"))
    marks = sets.select("tables", F.col("read_at").alias("at"), F.lit(1).alias("read"), F.lit(None).cast("long").alias("depends_on"))
    both = marks.unionByName(wanted.select("tables", "at", F.lit(0).alias("read"), "depends_on")).withColumn("hour", F.date_trunc("hour", "at"))
    within = both.withColumn("here", F.sum("read").over(Window.partitionBy("tables", "hour").orderBy(F.desc("at"))))  # reads at the same time count
    hours = both.groupBy("tables", "hour").agg(F.sum("read").alias("n"))
    later = hours.withColumn("later", F.coalesce(F.sum("n").over(Window.partitionBy("tables").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = within.filter("read = 0").join(later.select("tables", "hour", "later"), ["tables", "hour"])
    own = sets.select(F.col("txid").alias("depends_on"), "tables", "read_at")
    less = F.when(F.col("read_at") >= F.col("at"), 1).otherwise(0)  # a transaction does not depend on itself
    return counted.join(own, ["depends_on", "tables"], "left").groupBy("depends_on").agg(F.sum(F.col("here") + F.col("later") - less).alias("n"))


def dependent_counts(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """(txid, exact_dependents, over_approx_dependents), as precision() labels the conflicts, without the coarse edges.

    Only pairs that met on a key are listed. A wide read labelled tuple (its key is not known)
    counts as exact, like in the list; a pair found both ways counts once.
    """
    h = tracked_writes(history)
    pairs = ww_conflicts(history).unionByName(rw_edges(history, read_set, coarse=False).select("txid", "depends_on")).distinct()
    wide = read_set.filter("locktype <> 2 OR read_pk IS NULL").join(readers(history), "reader_xid").select("table_name", "locktype", "txid", "read_at").distinct()
    writers = h.groupBy("table_name", F.col("txid").alias("depends_on")).agg(F.min("committed_at").alias("written_at"))
    total = pairs.groupBy("depends_on").agg(F.count("*").alias("pairs"))
    parts = [total]
    for name, reads in (("any", wide.drop("locktype").distinct()), ("tuple", wide.filter("locktype = 2").drop("locktype"))):
        seen = pairs.join(reads, "txid").join(writers, ["table_name", "depends_on"]).filter("read_at >= written_at").select("txid", "depends_on").distinct()
        parts += [_readers_from(writers, reads).withColumnRenamed("n", f"n_{name}"), seen.groupBy("depends_on").agg(F.count("*").alias(f"seen_{name}"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "depends_on", "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    exact, every = n("pairs") + n("n_tuple") - n("seen_tuple"), n("pairs") + n("n_any") - n("seen_any")
    return out.select(F.col("depends_on").alias("txid"), exact.alias("exact_dependents"), (every - exact).alias("over_approx_dependents")).filter("exact_dependents + over_approx_dependents > 0")
